"""Whether a stored page was fetched by a user who is logged in, by signs of its platform in the order in which they count."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import vocabulary as V
from siftline.functions.batches import in_pieces
from siftline.functions.html import Node
from siftline.functions.markup import Page
from siftline.functions.selectors import matcher

TESTS = ("there", "avatar", "name", "address")


@dataclass(frozen=True)
class Sign:
    """What shows a login, in the order given: the first element of a selector, or a part of the page's address.

    ``there``: the element is; ``avatar``: it is a picture of a user's own; ``name``: it has text, which is the user's name;
    ``address``: ``what`` are parts of the address. ``named``: of which selectors the text is the name besides.
    """

    method: str
    test: str
    what: tuple[str, ...]
    named: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.test not in TESTS:
            raise ValueError(f"no such sign: {self.test}")


@dataclass(frozen=True)
class Signs:
    signs: tuple[Sign, ...]
    buttons: tuple[str, ...] = ()

    def selectors(self) -> tuple[str, ...]:
        """All of them, for one matcher."""
        return (*(x for s in self.signs if s.test != "address" for x in s.what), *self.buttons)


#: Signs of the platforms that have any; scripts and cookies are not in a stored page.
PLATFORM_SIGNS = {
    "weibo": Signs((Sign("selector", "there", tuple(V.WEIBO_USER), tuple(V.USER_NAMES)),), tuple(V.WEIBO_LOGIN)),
    "douyin": Signs((Sign("selector", "there", tuple(V.DOUYIN_USER), tuple(V.USER_NAMES)),), tuple(V.DOUYIN_LOGIN)),
    "xiaohongshu": Signs(
        (
            Sign("avatar_detected", "avatar", tuple(V.XHS_AVATARS)),
            Sign("username_detected", "name", tuple(V.XHS_NAMES)),
            Sign("menu_detected", "there", tuple(V.XHS_MENUS)),
            Sign("url_pattern_detected", "address", tuple(V.XHS_USER_PATHS)),
            Sign("indicator", "there", tuple(V.XHS_INDICATORS)),
        ),
        tuple(V.XHS_LOGIN),
    ),
}


def text_of(node: Node) -> str:
    return "".join(node.texts()).strip()


def state_of(html: str, url: str, signs: Signs) -> tuple[bool, str | None, bool, str | None]:
    """is_logged_in, login_user, has_login_button, detection_method (the sign and what of it was found) of a page."""
    selectors = signs.selectors()
    first = {s: nodes[0] for s, nodes in zip(selectors, matcher(selectors).hits(Page(html).root), strict=True) if nodes}
    for sign in signs.signs:
        for what in sign.what:
            if sign.test == "address":
                if what in url:
                    return True, None, False, f"{sign.method}:{url}"
                continue
            node = first.get(what)
            if node is None:
                continue
            text, src = text_of(node), node.attrs.get("src", "").lower()
            if sign.test == "name" and not text or sign.test == "avatar" and ("avatar" not in src or "default" in src):
                continue
            return True, text if sign.test == "name" or what in sign.named else None, False, f"{sign.method}:{what}"
    return False, None, any(x in first for x in signs.buttons), None


def login_states(pages: DataFrame, signs: dict[str, Signs] = PLATFORM_SIGNS, platform: str = "platform") -> DataFrame:
    """(page_id, is_logged_in, login_user, has_login_button, detection_method). A platform without signs shows no login.

    A null page has no elements, a null address no parts; a page that can't be read is null throughout.
    """
    for of in signs.values():  # what is wrong with a selector is said before a job begins
        matcher(of.selectors())
    given = pages.select("page_id", F.col(platform).cast("string").alias("platform"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    schema = given.select("page_id").schema.add("is_logged_in", "boolean").add("login_user", "string").add("has_login_button", "boolean").add("detection_method", "string")

    def one(platform: str | None, url: str | None, html: str | None) -> tuple:
        try:
            return state_of(html or "", url or "", signs.get(platform, Signs(())))
        except Exception:
            return None, None, None, None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.bool_(), pa.string(), pa.bool_(), pa.string()]
        for batch in in_pieces(batches):
            made = [one(*x) for x in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            columns = list(zip(*made, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

    return given.mapInArrow(rows, schema)
